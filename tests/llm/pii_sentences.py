"""Sentences written by hand, with their mentions marked as [[kind|mention]].

They share no wording with the frames or the generator the tagger is trained on
and only serve measuring. All persons, numbers and addresses are invented.
"""

import re

KINDS = {"n": "name", "e": "email", "p": "phone", "i": "identity", "a": "address"}

SENTENCES = """
Could you put me through to [[n|Laura Chen]] in accounts?
The cheque bounced, so [[n|Michael Dunne]] had to wire the deposit again.
Our new caretaker, [[n|Abigail Foster]], starts on the first of the month.
Yesterday evening [[n|Owen Hargreaves]] dropped the spare key through the letterbox.
Nobody has heard from [[n|Naomi Blackwood]] since the street party.
I bought the walking frame second-hand from [[n|Trevor Ellison]].
Minutes were taken by [[n|Fiona McAllister]] and approved by [[n|Gareth Pugh]].
Her name tag said [[n|Yvonne Baptiste]], but she answered to another name.
Please thank [[n|Desmond Okafor]] for clearing the snow outside the pharmacy.
The petition was started by [[n|Ingrid Solberg]] two winters ago.
You were seen parking on the ramp, [[n|Philip Ashworth]]!
Only [[n|Rosalind Perkins]] knows where the master key hangs.
The ambulance crew spoke with [[n|Harold Finch]] at the scene.
We owe [[n|Beatrice Langley]] an apology and a refund.
Drop me a line at [[e|gillian.marsh@westbrook.org]] when the works finish.
Photos can go straight into [[e|potholes@ourtown.gov.uk]] without a subject line.
Our treasurer uses [[e|t.okonkwo88@fastmail.com]] for invoices.
Unsubscribe by sending a blank message to [[e|leave-list@walkers.net]].
My old account, [[e|bluekettle_77@yahoo.com]], was hacked in May.
The address printed on the leaflet was [[e|hello (at) rampsforall (dot) org]].
Spam keeps arriving from [[e|winner2024@prizes.info]].
Bounced twice: [[e|JOHN.TALBOT@COUNCIL.GOV]].
Use [[e|night-desk@shelter.example]] outside office hours.
If the bell is broken, ring [[p|020 7946 0712]].
Out-of-hours repairs: [[p|0161 496 0345]].
She scribbled [[p|(415) 555-0137]] on the back of the ticket.
The van had [[p|07700 900461]] painted on its door.
Our US office answers on [[p|+1 212 555 0188]] until six.
Voicemail from [[p|+44 7911 123456]] came in at dawn.
Try the other line, [[p|617-555-0164]], if it is engaged.
Has anyone saved the plumber? It was [[p|01632 960 123]], I think.
The helpline changed to [[p|0808 157 0192]] in January.
Her SSN is [[i|123-45-6789]].
The clerk read out [[i|987-65-4320]] in front of everyone, which is my social security number.
His passport, [[i|AB1234567]], expired on the ferry.
The national insurance number on file is [[i|QQ 12 34 56 C]].
Someone else was using her ID card [[i|XR482915]] at the border.
Quote your social security number ([[i|321-54-9876]]) on every page.
We have moved to [[a|14 Willow Lane]].
The skip must not block [[a|221 Baker Street]].
Take the second door of [[a|9 Harbour Road, Flat 3]].
Rubbish piles up behind [[a|87 Cromwell Avenue]].
The hearing is about the steps of [[a|1200 Lincoln Avenue, Apt 5B]].
Every parcel meant for [[a|3 Orchard Way]] ends up next door.
The kerb was lowered in front of [[a|56 Station Road]].
A tree came down across the drive of [[a|410 Maple Street]] during the storm.
Whoever owns [[a|28A Mill Lane]] has narrowed the footway.
[[n|Claire Whitfield]] ([[e|claire.w@northgate.co.uk]]) will chair the panel.
Leave the forms with [[n|Samuel Adeyemi]], [[a|72 Grove Street]].
The landlord is [[n|Victor Pemberton]]; his mobile is [[p|07700 900982]].
Refund to be paid to [[n|Gwen Davenport]], SSN [[i|555-12-3498]].
For keys see [[n|Martha Kowalski]], phone [[p|0113 496 0998]], or knock at [[a|5 Chapel Lane]].
I, [[n|Edward Lockhart]], residing at [[a|19 Beech Avenue]], object to the plan.
Passenger: [[n|Sophie Tremblay]]; document: [[i|KX7719034]].
Send the bill to [[n|Louis Armitage]] at [[e|louis@armitage.net]], not to me.
[[n|Priscilla Boateng]] reported the loose slab and left [[p|020 7946 0958]] for questions.
The driver, [[n|Anthony Rizzo]], apologised to [[n|Helen Szymanski]].
Booked under [[n|Keira Donnelly]] for Tuesday, table by the ramp.
Two signatures are missing: [[n|Alan Whitcombe]] and [[n|Doris Eccles]].
Feedback from [[n|Jonas Lindqvist]]: the bus ramp jams in cold weather.
The caller gave her name as [[n|Miriam Goldfarb]] and hung up.
Chair: [[n|P. Rutherford]]. Secretary: [[n|Anita M. Desai]].
No lift at Holloway Road station this week.
The school on Crane Street keeps its gate locked after four.
Invoice 88213 covers twelve bollards and two benches.
Platform 4 is closed between 10:30 and 11:45 on 12/06/2023.
Ticket 5521-908 was merged with an older one.
Saint Mary Hospital has the only step-free entrance for miles.
Model RX-4410 ramps carry up to 300 kg.
Rosewood Foundation paid for the handrails.
The path between Elm Road and Market Street floods every spring.
Version 3.14.2 of the map shows 1287 crossings.
Serial number 99-310-2277 is stamped under the seat.
Follow @kerbwatch for updates on the closures.
Sign the waiver, scan it and post it back by Friday.
Quem abriu o portão foi a [[n|Cláudia Menezes]], do segundo turno.
O síndico novo chama-se [[n|Otávio Brandão]].
Perdi o contato com [[n|Renata Figueiredo]] depois da mudança.
A bengala esquecida no ônibus é do [[n|Sebastião Queiroz]].
Entregue este bilhete à [[n|Heloísa Vasconcelos]], por gentileza.
Ontem [[n|Wagner Siqueira]] varreu a rampa sozinho.
Foi [[n|Adriana Paixão]] quem desenhou o novo cruzamento.
Ficou decidido que [[n|Murilo Andrade]] cuidará das chaves.
Nunca vi [[n|Zilda Monteiro]] reclamar de nada.
O recado veio de [[n|Leandro Peixoto]], lá da oficina.
Avise também [[n|Tereza Cristina Lobo]] sobre a vistoria.
Parabéns a [[n|Ulisses Tavares]] pela obra!
Qualquer dúvida, [[e|ouvidoria@prefeitura.gov.br]] resolve.
Mandei as fotos da guia para [[e|mobilidade.urbana@cidade.org.br]] três vezes.
O boletim sai de [[e|noticias_bairro@uol.com.br]] toda segunda.
Meu endereço antigo, [[e|nandinha85@hotmail.com]], não existe mais.
Currículos em [[e|vagas@construtora.com.br]] até sexta.
Anote aí: [[e|zeca arroba oficina ponto com]].
O convite chegou por [[e|convites@teatro.pt]] ontem à noite.
Para denúncias anônimas existe o [[p|(11) 3456-7890]].
O zelador atende no [[p|(21) 98765-4321]] depois das oito.
Chegou mensagem de [[p|+55 31 99876-5432]] com a localização.
Em Lisboa o balcão usa [[p|+351 21 345 6789]].
O número da portaria mudou: agora é [[p|3322-4455]].
Guincho 24 horas: [[p|(85) 4004-1234]].
Deixe recado no [[p|81 99123-4567]] que eu retorno.
O CPF [[i|123.456.789-09]] consta duas vezes na lista.
Informe o RG [[i|12.345.678-9]] na entrada do prédio.
Consta no cadastro o documento [[i|987.654.321-00]], já vencido.
Esqueceram de tarjar o CPF [[i|111.222.333-44]] na ata.
O passaporte dela, [[i|FT482910]], sumiu no aeroporto.
Cadastro em nome de terceiro: CPF [[i|45678912300]].
O muro caiu na [[a|Rua das Acácias, 45]].
A van para sempre diante da [[a|Avenida Paulista, 1578]].
Há um buraco enorme junto à [[a|Travessa do Carmo, 12]].
O leilão será na [[a|Praça da Liberdade, 200]], sem elevador.
A casa amarela, [[a|Rua Marechal Deodoro, 733]], está à venda.
O abaixo-assinado circula na [[a|Alameda Santos, 981, apto 32]].
Instalaram o corrimão da [[a|Av. Brasil, 4020]] ao contrário.
A feira ocupa o passeio da [[a|Rua Sete de Abril, 59]].
A mudança saiu da [[a|Rua do Sol, 118 - casa 2]] às seis.
[[n|Fabiana Coutinho]], inscrita no CPF [[i|222.333.444-55]], autoriza a poda.
Pergunte por [[n|Everton Maciel]] no [[p|(47) 99988-7766]].
O orçamento de [[n|Sônia Guimarães]] foi para [[e|sonia.g@marmoraria.com]].
[[n|Ícaro Bittencourt]] reside na [[a|Rua Padre Chagas, 310]].
Testemunhas: [[n|Marli Assunção]] e [[n|Davi Nascimento]].
Ligação de [[n|Rosângela Prates]] às nove, pede retorno no [[p|(62) 3211-0099]].
A chave extra fica com [[n|Jurandir Falcão]], [[a|Rua Ipiranga, 88]].
Passei o caso para [[n|Eduarda Vilela]] ([[e|eduarda@defensoria.org]]).
Atendimento encerrado por [[n|Gilberto Amorim]] às 17h40.
Paguei o conserto ao [[n|Nelson Teófilo]] em duas vezes.
Relatora: [[n|Vera Lúcia Prado]]. Revisor: [[n|H. Bastos]].
Escola Municipal Rui Barbosa fecha o portão ao meio-dia.
A Rua das Palmeiras alaga toda vez que chove.
O protocolo 2023.8841 foi arquivado sem resposta.
A Fundação Oswaldo Lima doou vinte bancos.
Ônibus 875 não baixa a plataforma na parada do hospital.
Medimos 92 cm entre o poste e o muro, às 14:20.
Foram gastos R$ 3.450,00 em tinta amarela.
O trecho entre a Rua Augusta e a Alameda Jaú está sem luz.
Siga @calcadaviva nas redes.
Nota fiscal 004512 emitida em 30/09/2022.
Praça Sete recebeu piso tátil no ano passado.
A escada rolante parou de novo na Estação Sé.
La llave del portal la tiene [[n|Encarna Robledo]].
Al final firmó [[n|Ginés Carrasco]] en lugar del alcalde.
Ayer [[n|Macarena Olmedo]] pintó el bordillo de amarillo.
¿Sabe alguien si [[n|Fermín Arribas]] sigue de conserje?
El perro guía es de [[n|Aurora Pedraza]], no mío.
Gracias a [[n|Néstor Villanueva]] tenemos rampa nueva.
La queja más larga la redactó [[n|Adela Cifuentes]].
Se lo prometí a [[n|Joaquín Baeza]] y lo cumpliré.
Salió en la foto [[n|Remedios Tejada]] junto al ascensor.
Nos recibió [[n|Saturnino Ledesma]], muy amable.
Faltan por votar [[n|Candela Pizarro]] y [[n|Eugenio Lara]].
Convocó la junta [[n|Mercedes Ochoa Rincón]].
Las facturas, siempre a [[e|administracion@fincasnorte.es]].
Le contesté desde [[e|elena_87@telefonica.net]] el lunes.
Dudas y sugerencias: [[e|accesibilidad@ayuntamiento.org]].
El cartel pone [[e|info@rampasya.com]] en letra minúscula.
Rebotó el mensaje a [[e|p.soto@colegio.edu]].
Mi hija abrió la cuenta [[e|lunalunera22@gmail.com]] sin permiso.
Apunta: [[e|taller arroba ruedas punto es]].
El cerrajero cogió el [[p|612 345 678]] a la primera.
Centralita nueva: [[p|91 456 78 90]].
Hay tres llamadas perdidas del [[p|+34 699 112 233]].
El bono se pide en el [[p|900 123 456]].
En México contestan en el [[p|+52 55 1234 5678]].
Dejó apuntado [[p|954 12 34 56]] en la servilleta.
Urgencias de grúa: [[p|0034 655 443 322]].
Presentó el DNI [[i|12345678Z]] caducado.
Con el NIE [[i|X1234567L]] no dejaba pedir la tarjeta.
En la hoja figura el DNI [[i|87.654.321-X]], mal escrito.
El pasaporte [[i|AAB123456]] apareció en la papelera.
Han publicado por error el NIF [[i|45678901-R]] de la ganadora.
El contenedor tapa [[a|Calle Mayor, 27]].
Los escalones de [[a|Avenida de la Constitución, 14]] resbalan.
Se alquila local en [[a|Plaza del Mercado, 3]].
El taxi se equivocó y fue a [[a|Calle Toledo 118]].
Quieren quitar el vado de [[a|C/ Alcalá, 310, 2.º B]].
Al lado de [[a|Paseo de Gracia, 92]] hay un socavón.
La mudanza corta la acera en [[a|Calle Sierpes, 45, bajo]].
Reunión abierta en [[a|Travesía del Pozo, 6]], sótano.
[[n|Leonor Quesada]], con DNI [[i|23456789-D]], recurre la multa.
El paquete era para [[n|Baltasar Rueda]], [[a|Calle Luna, 8]].
Llame mejor a [[n|Nieves Santamaría]], [[p|655 443 322]].
Respondió [[n|Gonzalo Ferrer]] desde [[e|gferrer@gestoria.es]].
Asistieron [[n|Alba Montoya]] y [[n|Rodrigo Sáez]]; excusó su ausencia [[n|Teófilo Gil]].
Propietaria: [[n|Carlota Vidal]]. Inquilino: [[n|Samir Haddad]].
Ha llamado [[n|Inés Figueroa]] tres veces desde el [[p|628 90 12 34]].
El parte lo rellenó [[n|Mateo Urrutia]] en [[a|Calle Olmo, 19]].
Devuelvan la fianza a [[n|Estrella Montes]] (NIE [[i|Y7654321B]]).
Por orden de [[n|Ramiro Escudero]] se retiró la valla.
Colegio Público Miguel Hernández, entrada por el patio.
La Calle del Agua sigue cortada desde el martes.
El expediente 331/2021 no admite recurso.
Fundación Lázaro costeó las barandillas.
Autobús 27, parada sin plataforma hasta nuevo aviso.
Entre Calle Ancha y Calle Nueva no hay paso para sillas.
El presupuesto sube a 12.300 euros.
La pendiente es del 9 % en 14 metros.
Hospital Virgen del Rocío, puerta norte, ascensor averiado.
Factura 20214 abonada el 03/11/2021.
Sigan a @acerasvivas para más noticias.
Plaza Nueva tiene pavimento podotáctil desde abril.
""".strip().split("\n")

#: Written after the tagger and its form checks were finished, and never used to change them.
FRESH = """
Somebody called [[n|Tamsin Hollis]] wants the bench moved two yards south.
I was told to hand the badge to [[n|Curtis Delaney]] at gate four.
Kind words from [[n|Marguerite Dufresne]] after the new lift opened.
[[n|Alistair Munro]] slipped a note under my door last night.
Ask whether [[n|Bernadette Quigley]] still keeps the spare ramp in her garage.
The inspector scribbled [[p|0121 496 0423]] beside the crack.
After six, dial [[p|(303) 555-0119]] and wait for the tone.
Anything urgent goes to [[e|duty.officer@bridgeton.gov]] first.
He insists his email is [[e|rockhound1962@aol.com]], dots or no dots.
The bin lorry cannot turn near [[a|33 Sycamore Crescent]].
They demolished the porch of [[a|118 Victoria Road]] overnight.
Stamped on the permit: SSN [[i|402-11-7788]].
Her passport [[i|PA4419072]] was copied at reception.
[[n|Winston Achebe]], [[a|7 Linden Close]], asked for an audible signal.
Minutes go to [[n|Petra Novak]] via [[e|petra@novakdesign.com]].
Bridge Street reopens on 14 June after ten weeks.
The order 7782-19 is still at the depot.
Riverside Library lends folding ramps on Thursdays.
Quem regou as plantas foi [[n|Dirceu Barcelos]], como sempre.
A multa chegou em nome de [[n|Solange Meireles]].
Vi [[n|Anselmo Quintela]] empurrando o carrinho na ladeira.
A prova de vida do [[n|Aluísio Ferraz]] vence amanhã.
Escrevi ao jornal pelo [[e|cartas@diariodosul.com.br]] e nada.
O técnico deixou o ramal [[p|(51) 3222-8090]] anotado na parede.
Só respondem no [[p|+55 71 98123-4455]], e devagar.
Na faixa em frente à [[a|Rua General Osório, 221]] ninguém para.
Um cano estourou na [[a|Avenida Getúlio Vargas, 1040]].
O CPF [[i|765.432.109-87]] do inquilino não confere.
[[n|Noêmia Sardinha]] vende a cadeira por telefone, [[p|(19) 99701-2233]].
O degrau da Rua Bento Gonçalves tem 18 cm.
Escola Técnica Vital Brazil, portão dos fundos.
Trajo la denuncia [[n|Hortensia Galindo]] en mano.
No encuentro a [[n|Severino Blanes]] por ningún lado.
El ramo es para [[n|Maribel Ontiveros]], de la tercera planta.
Recogió las firmas [[n|Leandro Cabezas]] puerta por puerta.
Escríbeme a [[e|tomasin.rey@correo.es]] cuando abran.
Contesta un robot en el [[p|93 412 55 66]].
Dejaron el andamio en [[a|Calle del Pez, 17]].
La grúa se llevó el coche de [[a|Avenida de América, 64]].
Consta el DNI [[i|50123456K]] en la solicitud.
El acta 17/2020 quedó sin firmar.
Biblioteca Pública Carmen Laforet, sin rampa.
""".strip().split("\n")

_MARK = re.compile(r"\[\[(\w)\|(.+?)\]\]")


def labelled(sentences=SENTENCES):
    """[(text, [(start, end, kind)])] of all sentences."""
    out = []
    for line in sentences:
        text, spans, last = "", [], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            spans.append((len(text), len(text) + len(m.group(2)), KINDS[m.group(1)]))
            text += m.group(2)
            last = m.end()
        out.append((text + line[last:], spans))
    return out
